import math
import random
from collections import Counter

import pytest

from gleanframe.llm import urls
from gleanframe.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, host int, _label string"


def test_rules_hosts_and_paths(spark):
    cases = [("https://A.Example.com/en/1?x=/y#z", "a.example.com", "/en/1", "example.com/en/", "block"),
             ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"), ("http://x.net/de/", "x.net", "/de/", None, None),
             ("http://b.com/", "b.com", "/", "com/", "allow"), ("http://b.com", "b.com", "", None, None),
             ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("http://notcom/", "notcom", "/", None, None)]
    df = spark.createDataFrame([(i, c[0], 1, "x") for i, c in enumerate(cases)], SCHEMA)
    got = {r.page_id: r for r in urls.judge_urls(df, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), cases[i]
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_held_out_urls(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.5
        word = "".join(rng.choice("abcdefgh") for _ in range(6))
        url = f"http://{word}.bad{rng.randrange(10 ** 6)}.org/{word}/{rng.randrange(10 ** 9)}?a={i}&b=2&c=3" if bad else f"http://{word}.good.org/{word}"
        held = i >= 600
        rows.append((i, url, bad, held))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean, held boolean")
    placed = df.withColumns({"host": urls.host_of(df["url"]), "path": urls.path_of(df["url"])})
    from pyspark.sql import functions as F
    ready = urls.suffix_statistics(urls.lexical_features(placed), "label", 64) if False else urls.suffix_statistics(
        urls.lexical_features(placed.withColumn("label", F.when(~F.col("held"), F.col("bad").cast("int")))), "label", 64)
    model = urls.train(ready.where("label is not null"), "label", ("url",), trees=5)
    from pyspark.ml.feature import VectorAssembler
    scored = model.transform(VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(ready.where("held").drop("label")))
    hit = [(r.prediction > 0.5) == r.bad for r in scored.select("prediction", "bad").collect()]
    assert sum(hit) / len(hit) > 0.95


@pytest.mark.parametrize("few", [64, 10_000])
def test_every_suffix_has_its_own_odds(spark, few):
    rng = random.Random(5)
    hosts = [f"a.d{rng.randrange(3000)}.t{rng.randrange(90)}" for _ in range(6000)] + ["hot.com"] * 2000 + ["", "x"]
    rows = [(i, h, rng.choice([0, 1, None]) if h != "x" else None) for i, h in enumerate(hosts)]
    got = urls.suffix_statistics(spark.createDataFrame(rows, "i int, host string, label int"), "label", few).collect()
    seen = Counter((k, ".".join(h.split(".")[-k:]), v) for _, h, v in rows for k in (1, 2))
    odds = lambda k, h: math.log((seen[k, h, 1] + 1) / (seen[k, h, 0] + 1))
    assert sorted(r.i for r in got) == list(range(len(rows)))
    for r in got:
        labels = r.host.split(".")
        assert r.suffix_odds == pytest.approx(odds(1, labels[-1])), r.host
        assert r.domain_odds == pytest.approx(odds(2, ".".join(labels[-2:]))), r.host


def test_labelled_rows_take_odds_of_other_folds(spark):
    from pyspark.sql import functions as F
    rng = random.Random(6)
    rows = [(i, f"a.d{rng.randrange(20)}.t{rng.randrange(3)}", rng.choice([0, 1, None]), rng.randrange(urls.FOLDS)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, host string, label int, part int")
    got = {r.i: r for r in urls.suffix_statistics(df, "label", fold=F.col("part")).collect()}
    for i, host, label, part in rows:
        for name, k in (("suffix_odds", 1), ("domain_odds", 2)):
            seen = Counter(l for _, h, l, p in rows if h.split(".")[-k:] == host.split(".")[-k:] and (label is None or p != part))
            assert got[i][name] == pytest.approx(math.log((seen[1] + 1) / (seen[0] + 1)))


def held_out_pages(spark, folder):
    """(rows, share judged right, share of the larger class) of the labelled urls of a fifth, which the model has not seen."""
    from pyspark.sql import functions as F
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.col("url").alias("_url"))
    placed = pages.withColumns({"host": urls.host_of(F.col("_url")), "path": urls.path_of(F.col("_url"))})
    truth = (urls.rule_columns(F.col("host"), F.col("path"), URL_RULES)[1] == "block").cast("int")
    held = F.pmod(F.xxhash64("_url", F.lit("held out")), F.lit(5)) == 0
    rows = placed.withColumns({"_truth": truth, "_label": F.when(~held, truth)})
    judged = urls.block_probabilities(rows, "_label", "_url").where(F.col("_label").isNull() & F.col("_truth").isNotNull())
    n, right, blocks = judged.agg(F.count("*"), F.avg(((F.col("block_probability") > 0.5).cast("int") == F.col("_truth")).cast("int")),
                                  F.avg("_truth")).first()
    return n, right, max(blocks, 1 - blocks)


def test_held_out_pages(spark):
    n, right, larger = held_out_pages(spark, "/root/testdata/sf0.1")
    assert n > 0 and right > max(0.9, larger)


def test_columns_of_any_name_are_kept(spark):
    names = ["_label", "_url", "_fold", "_suffix", "_verdict", "entropy", "depth", "features", "prediction", "_kept_0", "a.b"]
    rows = [(f"http://x{i}.net/{'es' if i % 2 else 'de'}/", *[f"{k}{i}" for k in range(len(names))]) for i in range(6)]
    rows += [("http://y.com/", *["z"] * len(names))]
    df = spark.createDataFrame(rows, ["url", *names])
    got = urls.judge_urls(df, URL_RULES)
    assert got.columns == ["url", *names, "host", "path", "rule", "verdict", "block_probability"]
    assert sorted(tuple(r)[:len(names) + 1] for r in got.collect()) == sorted(rows)


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://b.com/", 1, "x"), (2, "http://c.org/", 1, "x"), (2, "http://c.org/", 1, "x")], SCHEMA)
    assert [r.verdict for r in urls.judge_urls(df, URL_RULES).collect()] == ["allow"] * 3
    assert urls.judge_urls(df.limit(0), URL_RULES).collect() == []
