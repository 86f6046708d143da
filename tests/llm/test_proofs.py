"""Plain versions of what SQL cannot express, planted graphs and declarations, and hard rows with clashing names."""

from __future__ import annotations

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import (
    decontaminate, language_id, lattice_lm, near_duplicates, oracle, quality_classifier, quality_rules, sampling, sentence_pieces, sharding, toxicity, url_filter,
)
from tests.llm.test_llm import DATA, HARD, MODEL, SPACED, near_spec, rules_spec

CLASH = "pos start cluster said rest key item id n text_ host path r label weight words word th win name band hub n_words score kept component_id".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Hard rows with columns of the names that operators use inside."""
    rows = [(i, t, "en", "src", None) for i, t in enumerate(HARD)] + [(None, "no id", None, None, None), (6, "A b c", "en", "src", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- samples -------------------------------------------------------------------------------------


def test_class_shares():
    assert sampling.class_shares({0: 900, 1: 100}, 2000) == {0: 900, 1: 100}
    got = sampling.class_shares({0: 10**9, 1: 50, 2: 10**6}, 8000)
    assert sum(got.values()) <= 8000 and got[1] == 50 and 333 <= got[2] <= 400 and got[0] > 7000
    assert sampling.class_shares({}, 10) == {}


def test_samples_are_bounded(spark):
    docs = spark.range(4000).select((F.col("id") % 1000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    labels = labels.union(spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, label int"))
    got = sampling.sampled_texts(docs, labels, "doc_id", "text", 200).collect()
    again = sampling.sampled_texts(docs, labels, "doc_id", "text", 200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    ids = [r["doc_id"] for r in got]
    assert 150 <= len(ids) == len(set(ids)) <= 200 and 3 not in ids
    assert 8 <= sum(r["label"] for r in got) <= 20 and sum(r["weight"] for r in got) == pytest.approx(999, rel=0.25)


# --- 4 -------------------------------------------------------------------------------------------


def differencing_spec(sizes, shards):
    """Partial partitions as lists of (sum, members), the two widest joined until one is left."""
    parts = [([(0, ())] * (shards - 1) + [(s, (i,))], i) for i, s in enumerate(sizes)]
    serial = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][-1][0] - p[0][0][0]), p[1]))
        (a, _), (b, _) = parts[:2]
        joined = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))]
        parts = [*parts[2:], (sorted(joined, key=lambda p: p[0]), serial)]
        serial += 1
    return [s for s, _ in parts[0][0]] if parts else [0] * shards


def test_differencing_equals_plain():
    rng = np.random.default_rng(3)
    for shards in (2, 3, 16):
        for sizes in ([7], [8, 7, 6, 5, 4], rng.integers(1, 10**6, 120).tolist(), [5] * 40):
            own = np.bincount(sharding.difference(sizes, shards), sizes, shards)
            low = min(differencing_spec(sizes, shards))
            assert sorted(own - own.min()) == sorted(x - low for x in differencing_spec(sizes, shards))


def test_shards_within_a_byte(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [r[1] for r in sharding.shard_by_bytes(docs).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 1


# --- 5 -------------------------------------------------------------------------------------------


def random_pages(rng, n=150):
    hosts = ["a.com", "www.example.com", "x.example.com", "example.com", "m.net", "net", "q.org", "deep.q.org"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/es/', '/fr/x/', '/', ''])}{rng.integers(0, 25)}"
    urls = [url() for _ in range(n)]
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head>'
    move = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    html = ["<html></html>"] * n
    for k in range(1, 40):  # chains, back links and cycles
        html[k] = (link if k % 2 else move)(urls[k - 1] if k % 7 else urls[k + 3])
    html[39] = link(urls[20])
    for k in range(60, 110):  # a hub
        urls[k] = f"http://q.org/p{k}"
        html[k] = link("http://m.net/es/hub") + (move("http://q.org/p60#x") if k % 11 == 0 else "")
    html[110], html[111], html[112] = link("/en/rel"), move("other/page"), link("//m.net/es/1")
    return [(k, u, h) for k, (u, h) in enumerate(zip(urls, html))] + [(900, None, link(urls[0])), (901, urls[3], None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_aliases_equal_sql(spark, seed):
    rows = random_pages(np.random.default_rng(seed))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(oracle.ORACLES["op5_url_filter"])
    got = url_filter.judge_urls(pages).select(*want.columns).collect()
    shown = sorted(str(tuple(r)) for r in got)
    assert shown == sorted(str(tuple(r)) for r in want.fetchall())
    assert sum(r["rule"] is None and r["verdict"] == "block" for r in got) > 3 and len({r["component"] for r in got}) > 3


def test_many_rules_equal_few(spark):
    rng = np.random.default_rng(7)
    hosts = ["com", "a.com", "example.com", "x.example.com", "net", "q.org", "nowhere.test"]
    rules = tuple({(str(rng.choice(["allow", "block"])), str(rng.choice(hosts)), str(rng.choice(["/", "/en/", "/e", "/es/1", "/fr/x/"]))) for _ in range(40)})
    pages = spark.createDataFrame(random_pages(rng), "page_id bigint, url string, html string")
    few = url_filter.judge_urls(pages, rules=rules)
    many = url_filter.judge_urls(pages, rules=spark.createDataFrame(list(rules), "verdict string, host string, path string"))
    shown = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert shown(few) == shown(many)
    long = rules + tuple(("block", f"h{k}.test", "/") for k in range(url_filter.MAX_RULES))
    assert shown(url_filter.judge_urls(pages, rules=long)) == shown(few)


# --- 6 -------------------------------------------------------------------------------------------


def fusion_spec(rows, model):
    """{row number: (language, confidence)} for (text, declared, host): every step as a loop."""
    langs, logs = [*model[0], "und"], np.vstack([model[1], np.full(model[1].shape[1], -np.log(model[1].shape[1]))])
    n, values = len(langs), [*model[0], "none", "other"]
    like, first, said, host = [], [], [], []
    for text, declared, h in rows:
        at = language_id._trigrams(text)
        like.append(logs[:, at].mean(axis=1) * min(len(at), language_id.EVIDENCE) if len(at) > 1 else np.zeros(n))
        p = np.exp(like[-1] - like[-1].max())
        first.append(p / p.sum())
        d = (declared or "").lower()
        said.append("none" if not d else d if d in model[0] else "other")
        host.append((h or "").lower())
    level = {"suffix": lambda h: h.rsplit(".", 1)[-1], "site": lambda h: ".".join(h.split(".")[-2:]), "host": lambda h: h}
    sums = {by: collections.defaultdict(lambda: np.zeros(n)) for by in level}
    of_said = collections.defaultdict(lambda: np.zeros(n))
    for f, s, h in zip(first, said, host):
        of_said[s] += f
        for by, cut in level.items():
            sums[by][cut(h)] += f
    whole = sum(of_said.values())
    out = []
    for f, lk, s, h in zip(first, like, said, host):
        given = np.log((of_said[s] + language_id.SLACK * whole / len(values) + 1e-3) / (whole * (1 + language_id.SLACK) + 1e-3 * len(values)))
        prior = (whole + 0.5) / (whole.sum() + 0.5 * n)
        for by, cut in level.items():
            rest = np.maximum(sums[by][cut(h)] - f, 0)
            prior = (rest + language_id.KAPPA * prior) / (rest.sum() + language_id.KAPPA)
        e = lk + given + np.log(prior)
        post = np.exp(e - e.max())
        post /= post.sum()
        out.append((langs[int(post.argmax())], post.max()))
    return out


def test_fusion_equals_plain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.text_model(docs)
    rng = np.random.default_rng(1)
    rows = [(r["text"][: int(rng.integers(0, 60))], str(rng.choice(["en", "FR", "xx", ""])), str(rng.choice(["a.b.com", "b.com", "c.b.com", "x.org", "com", ""]))) for r in docs.collect()]
    rows += [(None, None, None), ("", "de", "b.com"), ("1234", None, "b.com")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k bigint, t string, d string, h string")
    got = {r["k"]: r for r in language_id.identify(df, "k", F.col("t"), F.col("d"), F.col("h"), model).collect()}
    for k, (lang, sure) in enumerate(fusion_spec(rows, model)):
        assert got[k]["confidence"] == pytest.approx(sure, rel=1e-4) and (got[k]["language"] == lang or sure < 0.6), k


def test_held_out_languages(spark):
    """Wrong declarations are planted on a fifth of the rows; the model is fitted on the others' texts alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    model = language_id.text_model(docs.where("NOT out"))
    wrong = F.when(F.col("out"), F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang"))
    short = docs.withColumns({"said": wrong, "few": F.substring("text", 1, 25)})
    got = language_id.identify(short, "doc_id", F.col("few"), F.col("said"), F.lit("one.host"), model).join(docs.where("out").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["text_language"] == got["lang"]).mean() > 0.85 and (got["declared"] != got["lang"]).all()
    whole = language_id.identify(short, "doc_id", F.col("text"), F.col("said"), F.lit("one.host"), model).join(docs.where("out").select("doc_id", "lang"), "doc_id").toPandas()
    assert (whole["language"] == whole["lang"]).mean() > 0.95 and (whole["text_language"] == whole["lang"]).mean() > 0.97


def test_page_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.text_model(docs)
    texts = {lang: docs.where(F.col("lang") == lang).select("text").first()[0][:400] for lang in model[0]}
    rows, k = [], 0
    for lang, t in texts.items():
        other = next(x for x in model[0] if x != lang)
        page = lambda said, body: f"<html lang='{said}'><head><title>{texts[other]}</title></head><body><script>{texts[other]}</script><p>{body}</p></body></html>"
        for n in range(6):
            rows.append((k, f"http://{lang}.site-{lang}.test/{n}", page(lang, t), lang))
            k += 1
        rows += [(k, f"http://{lang}.site-{lang}.test/x", page(other, t), lang), (k + 1, f"http://{lang}.site-{lang}.test/y", page(lang, ""), lang), (k + 2, f"http://new.site-{lang}.test/y", "", lang)]
        k += 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    got = {r["page_id"]: r for r in language_id.page_languages(pages, model).collect()}
    assert [k for k, _, _, want in rows if got[k]["language"] != want] == []
    assert language_id.page_languages(pages.limit(0), model).count() == 0
    hard = spark.createDataFrame([(1, None, None), (2, "x", "<html lang=zz>"), (3, "http://h", "word " * 50_000)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["declared"] for r in language_id.page_languages(hard, model).collect()} == {1: "none", 2: "other", 3: "none"}


# --- 7 -------------------------------------------------------------------------------------------


def trees_spec(x, y):
    """Margins of boosting by loops over rows, features and cuts."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    share = y.mean()
    score = [float(np.log(share / (1 - share)))] * len(y)
    for _ in range(toxicity.TREES):
        p = [1 / (1 + np.exp(-s)) for s in score]
        g, h = [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]
        nodes = [list(range(len(y)))]
        for _ in range(toxicity.DEPTH):
            after = []
            for rows in nodes:
                best = (1e-6, None, None)
                for j, edges in enumerate(cuts):
                    for c in edges:
                        left = [i for i in rows if x[i, j] <= c]
                        right = [i for i in rows if x[i, j] > c]
                        part = lambda own: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + 1)
                        gain = part(left) + part(right) - part(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, c)
                _, j, c = best
                after += [rows, []] if j is None else [[i for i in rows if x[i, j] <= c], [i for i in rows if x[i, j] > c]]
            nodes = after
        for rows in nodes:
            step = sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1) * toxicity.RATE
            for i in rows:
                score[i] += step
    return np.array(score)


def test_trees_equal_plain(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 3)
    monkeypatch.setattr(toxicity, "BINS", 6)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.normal(size=60) > 0).astype(float)
    model = toxicity.boosted_trees(x, y)
    assert np.allclose(toxicity.margins(model, x), trees_spec(x, y), atol=1e-9)


def test_weighted_isotonic():
    x, y, w = np.array([1.0, 2, 2, 3]), np.array([1.0, 0, 1, 1]), np.array([3.0, 1, 1, 9])
    at, value = toxicity.isotonic(x, y, w)
    assert at.tolist() == [1, 2, 3] and np.allclose(value, [0.8, 0.8, 1.0])


# --- 10 ------------------------------------------------------------------------------------------


def ordinal_spec(at, x, grade, grades, weight):
    """Adagrad with numerical derivatives of the likelihood, a row at a time."""
    buckets = quality_classifier.BUCKETS
    weight = weight / weight.mean()
    share = np.array([np.average(grade > k, weights=weight) for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    w, gw, gr = np.zeros(buckets), np.full(buckets, 1e-6), np.full(len(raw), 1e-6)
    order, sig, eps = np.random.default_rng(0), lambda z: 1 / (1 + np.exp(-z)), 1e-6

    def one(f, raw, g):
        cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        hi = 1.0 if g == grades - 1 else sig(cuts[g] - f)
        return np.log(hi - (0.0 if g == 0 else sig(cuts[g - 1] - f)))

    for _ in range(quality_classifier.EPOCHS):
        for rows in np.array_split(order.permutation(len(grade)), max(1, len(grade) // quality_classifier.BATCH)):
            grad, graw = -quality_classifier.DECAY * w, np.zeros(len(raw))
            for i in rows:
                f = (w[at[i]] * x[i]).sum()
                df = (one(f + eps, raw, grade[i]) - one(f - eps, raw, grade[i])) / (2 * eps)
                np.add.at(grad, at[i], weight[i] * df * x[i] / len(rows))
                for k in range(len(raw)):
                    d = np.eye(len(raw))[k] * eps
                    graw[k] += weight[i] * (one(f, raw + d, grade[i]) - one(f, raw - d, grade[i])) / (2 * eps) / len(rows)
            gw += grad**2
            w = w + quality_classifier.RATE * grad / np.sqrt(gw)
            gr += graw**2
            raw = raw + 0.1 * graw / np.sqrt(gr)
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def test_ordinal_fit_equals_plain(monkeypatch):
    monkeypatch.setattr(quality_classifier, "BUCKETS", 40)
    monkeypatch.setattr(quality_classifier, "EPOCHS", 3)
    monkeypatch.setattr(quality_classifier, "BATCH", 16)
    rng = np.random.default_rng(6)
    grade = rng.integers(0, 3, 64)
    at = [np.unique(np.append(rng.integers(0, 30, 4), 30 + g)) for g in grade]
    x = [rng.random(len(a)) for a in at]
    weight = rng.random(64) + 0.5
    w, cuts = quality_classifier.fit_ordinal(at, x, grade, 3, weight)
    want, edges = ordinal_spec(at, x, grade, 3, weight)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(cuts, edges, atol=1e-4)


def test_half_grades_and_long_shapes(spark):
    kinds = {2.0: "good plain words", 2.5: "fair-ish words-and-marks", 4.0: "bad b!a!d!"}
    docs = spark.createDataFrame([(i, f"{t} " * 12 + f"x{i}") for i, t in enumerate(list(kinds.values()) * 150)], "doc_id bigint, text string")
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(list(kinds) * 150)], "doc_id bigint, quality double")
    got = quality_classifier.grade(docs, rated, from_grade=2.5).join(rated, "doc_id").toPandas()
    means = got.groupby("quality")["expected_grade"].mean()
    assert 2 <= means[2.0] < means[2.5] < means[4.0] <= 4 and ((got["tail_probability"] > 0.5) == (got["quality"] >= 2.5)).mean() > 0.95
    assert quality_classifier._slots("a.b.c.d.e.f.g!")[1] != quality_classifier._slots("a.b.c.d.e.f.g?")[1]


# --- hard rows, clashing names -------------------------------------------------------------------


def test_clashing_names(spark, clashing):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumns({c: F.lit("clash") for c in ("text", "label", "weight", "n", "key")})
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(clashing, allowMissingColumns=True)
    plain, rows = docs.select("doc_id", "text", "lang", "source", "n_chars"), docs.count()
    shown = lambda df: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect())
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").withColumns({c: F.lit("clash") for c in CLASH})
    for made in (
        lambda d: sentence_pieces.digests(sentence_pieces.encode_decode(d, MODEL)), lambda d: decontaminate.contamination(d, items), lambda d: near_duplicates.near_duplicates(d, size=3, percent=85),
        lambda d: sharding.shard_by_bytes(d).drop("slot"), lambda d: language_id.document_languages(d, language_id.text_model(d)), lambda d: toxicity.score(d, labels),
        lambda d: quality_rules.ledger(d), lambda d: lattice_lm.lm_scores(d, MODEL), lambda d: quality_classifier.grade(d, labels),
    ):
        got = shown(made(docs))
        assert len(got) == rows and got == shown(made(plain))
    pages = spark.createDataFrame([(k, f"http://h{k}.net/es/", "<html>") for k in range(5)] + [(9, None, None)], "page_id bigint, url string, html string")
    wide = pages.withColumns({c: F.lit("clash") for c in CLASH})
    assert shown(url_filter.judge_urls(wide)) == shown(url_filter.judge_urls(pages))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_scores_of_empty_texts(spark, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = docs.select("doc_id", "text").union(clashing.select(F.col("doc_id") + 10**6, "text"))
    hard_empty = [10**6 + i for i, t in enumerate(HARD) if not (t or "").split()]
    assert hard_empty
    tox = {r["doc_id"]: r for r in toxicity.score(both, labels).where("doc_id >= 1000000").collect()}
    grade = {r["doc_id"]: r for r in quality_classifier.grade(both, labels).where("doc_id >= 1000000").collect()}
    assert len({tox[i]["score"] for i in hard_empty}) == 1 and tox[hard_empty[0]]["predicted"] == 0
    assert len({grade[i]["expected_grade"] for i in hard_empty}) == 1
    assert tox[10**6 + HARD.index("idiot! YOU idiot")]["score"] > tox[hard_empty[0]]["score"]
    assert all(0 <= r["score"] <= 1 for r in tox.values()) and all(0 <= r["expected_grade"] <= 1 for r in grade.values())


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_plain(spark):
    """All five stages over the smallest tables, each as a plain loop."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]

    def clean(t):
        n, chars, symbols, dup, repeat = rules_spec(t)
        lines = len([x for x in (t or "").split("\n") if SPACED.search(x)])
        ok = n >= 50 and 100 * repeat <= 50 * n and 100 * symbols <= quality_rules.MAX_SYMBOL_PERCENT * n
        return ok and 100 * dup <= quality_rules.MAX_DUP_LINE_PERCENT * lines and chars <= quality_rules.MAX_MEAN_WORD * n

    rows = [r for r in rows if clean(r[1])]
    model = language_id.text_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    spoken = fusion_spec([r[1:] for r in rows], model)
    rows = [r for r, (lang, sure) in zip(rows, spoken) if lang != "und" and sure >= language_id.LEAST]
    near = near_spec([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for _, t in items if (w := re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    rows = [r for r in rows if not hit(r[1])]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t, *_ in rows for ids in [lib.encode(t)])
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and 50 < len(got) < 200
