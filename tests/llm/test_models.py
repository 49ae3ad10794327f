"""Toxicity and quality: held-out accuracy, and the grouped priors in plain Python."""

import random
import zlib

import numpy as np
from helpers import AWKWARD, clashing, empty, rows
from pyspark.sql import functions as F

from gridleaf.llm import quality, toxicity


class Levels(list):
    """Columns made where they are used, as they need a session."""

    def __iter__(self):
        return iter([F.col("source"), F.col("lang")])

    def __len__(self):
        return 2


SITE = Levels()


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "vile"])
        text = " ".join(w)
        docs.append((i, text.upper().replace(" ", "!! ") if junk and not toxic else text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(not (junk and not toxic)), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = rows(toxicity.toxicity(docs, labels))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    hit = np.mean([got[i]["predicted"] == truth[i] for i in held])
    assert hit > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(spark, 300)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = rows(toxicity.toxicity(docs, labels)), rows(toxicity.toxicity(docs, other))
    assert all(a[i]["score"] == b[i]["score"] for i in a)


def test_scores_of_awkward_rows(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.trained(docs, labels)
    found = toxicity.scores(clashing(spark), model).collect()
    assert len(found) == len(AWKWARD) and len({r["score"] for r in found if r["doc_id"] <= 3}) == 1
    none = toxicity.trained(docs, labels.limit(0))
    assert all(r["score"] == 0.0 for r in toxicity.scores(docs, none).collect())
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    docs, labels = corpus(spark)
    out = quality.judged(docs, labels, SITE, ["doc_id"])
    got = rows(out)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([got[i]["kept"] == bool(truth[i]) for i in truth]) > 0.98
    assert quality.reject(docs, labels, SITE).columns == docs.columns


def test_posteriors_against_python(spark):
    """Sums, weights and leave-one-out posteriors of three levels, in plain Python."""
    rng = random.Random(2)
    rows_ = [(f"{h}{p}{q}", h, p, q, rng.gauss(m + 0.3 * q, 1)) for h, m, n in (("a", 1, 60), ("b", -1, 40), ("c", 2, 1), (None, 0, 5)) for p in range(3) for q in range(2) for _ in range(n)]
    scores = spark.createDataFrame(rows_, "id string, a string, b int, c int, e double")
    joined, columns = quality._with_posterior(scores, ["a", "b", "c"], "e", 0.35)
    got = {(r["e"], r["id"]): r for r in joined.select(columns["id"], columns["e"], *(columns[f"/{k}"] for k in ("p_host", "p_path", "posterior", "kept"))).collect()}
    p = lambda e: 1 / (1 + np.exp(-e))
    groups = [{}, {}, {}]
    for _, h, b, c, e in rows_:
        for g, key in zip(groups, ((h,), (h, b), (h, b, c)), strict=True):
            n, t = g.get(key, (0, 0.0))
            g[key] = (n + 1, t + p(e))
    top = sum(p(r[4]) for r in rows_) / len(rows_)

    def mean(key, ks, less=None):
        m = top
        for i, k in enumerate(ks):
            n, t = groups[i][key[: i + 1]]
            n, t = (n, t) if less is None else (n - 1, max(t - less, 0.0))
            m = (t + k * m) / (n + k)
        return m

    ks = []
    for g in groups:
        items = [(n, t / n, mean(key, ks)) for key, (n, t) in g.items()]
        within = np.mean([m * (1 - m) for _, _, m in items])
        total = sum(n for n, _, _ in items)
        between = sum(n * (x - m) ** 2 for n, x, m in items) / total - len(items) * within / total
        ks.append(min(1000.0, max(1.0, within / max(between, 1e-6))))
    logit = lambda x: np.log(x / (1 - x))
    for i, h, b, c, e in rows_:
        r = got[e, i]
        host, path = mean((h, b, c), ks[:1], p(e)), mean((h, b, c), ks, p(e))
        post = p(e + logit(path) - logit(top))
        assert abs(r["p_host"] - host) < 1e-9 and abs(r["p_path"] - path) < 1e-9 and abs(r["posterior"] - post) < 1e-9 and r["kept"] == (post >= 0.35)


def test_urls_are_taken_apart(spark):
    urls = ["https://WWW.Example.com:8080/a/b/c?x=1", "http://u:p@example.com/#top", "no url", None, "ftp://host.example/one"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(*(c.alias(f"l{i}") for i, c in enumerate(quality.site(F.col("url"))))).collect()
    assert [tuple(r) for r in got] == [("example.com", "example.com/a", "example.com/a/b"), ("example.com",) * 3, (None,) * 3, (None,) * 3, ("host.example", "host.example/one", "host.example/one")]


def test_sites_of_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    labels = pages.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    out = quality.judged(pages, labels, quality.site(F.col("url")), ["doc_id"])
    assert out.count() == pages.count() and out.where("posterior is null or posterior <= 0 or posterior >= 1").count() == 0


def test_gradients_and_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = toxicity.Net(np.arange(1, 9, dtype=np.uint64), rng.normal(0, 1, 8).astype(np.float32))
    rows_ = np.array([1, 5, 3, 0, 2, 8, 8, 4])
    padded = net.emb[np.concatenate([[0, 0], rows_, [0, 0]])]
    want = []
    for c, b in zip(net.conv, net.bias, strict=True):
        z = [sum(padded[i + j] @ c[j] for j in range(len(c))) for i in range(len(padded) - len(c) + 1)]
        want.append(np.maximum(np.max(z, axis=0) + b, 0))
    assert np.allclose(net.pooled(rows_, net.tables())[0], np.concatenate(want), atol=1e-5)
    grads = {k: np.zeros_like(v) for k, v in net._weights().items() if k != "emb"}
    touched = {}
    net._back(rows_, 1.0, net.tables(), grads, touched)
    loss = lambda: float(np.log1p(np.exp(-net.logit(rows_, net.tables()))))
    for name, w in net._weights().items():
        flat = w.reshape(-1)
        for at in rng.choice(len(flat), min(4, len(flat)), replace=False) if name != "emb" else [8 * 5 + 2]:
            old = flat[at]
            flat[at] = old + 1e-3
            up = loss()
            flat[at] = old - 1e-3
            down = loss()
            flat[at] = old
            have = touched.get(5, np.zeros(8))[2] if name == "emb" else grads[name].reshape(-1)[at]
            assert abs((up - down) / 2e-3 - have) < 2e-2, name


def test_quality_of_awkward_rows(spark):
    docs, labels = corpus(spark, 100)
    out = quality.judged(clashing(spark), labels.limit(0), SITE, ["doc_id", "kept"])
    assert out.count() == len(AWKWARD)
    kept = quality.reject(clashing(spark), labels.limit(0), SITE)
    assert kept.columns == clashing(spark).columns and kept.count() == len(AWKWARD)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in clashing(spark).collect()}
    assert quality.judged(empty(spark), labels, SITE, ["doc_id"]).count() == 0
